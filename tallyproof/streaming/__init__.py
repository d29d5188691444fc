"""tallyproof.streaming"""
