"""tallyproof.functions"""
