"""cadenza.plans"""
