"""gaugeline.streaming"""
