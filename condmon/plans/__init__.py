"""condmon.plans"""
