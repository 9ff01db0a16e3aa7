"""condmon.streaming"""
