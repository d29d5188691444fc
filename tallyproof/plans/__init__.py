"""tallyproof.plans"""
