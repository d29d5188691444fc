"""tallyproof.sources"""
