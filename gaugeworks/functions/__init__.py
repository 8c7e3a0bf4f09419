"""gaugeworks.functions"""
