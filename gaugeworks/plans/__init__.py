"""gaugeworks.plans"""
