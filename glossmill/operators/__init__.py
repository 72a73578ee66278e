"""glossmill.operators"""
