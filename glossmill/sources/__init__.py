"""glossmill.sources"""
