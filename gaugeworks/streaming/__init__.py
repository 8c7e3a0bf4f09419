"""gaugeworks.streaming"""
