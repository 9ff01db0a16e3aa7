"""condmon.sources"""
