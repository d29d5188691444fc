"""tallyproof.operators"""
