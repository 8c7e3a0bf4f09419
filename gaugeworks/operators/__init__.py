"""gaugeworks.operators"""
