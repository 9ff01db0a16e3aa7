"""condmon.operators"""
