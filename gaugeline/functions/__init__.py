"""gaugeline.functions"""
