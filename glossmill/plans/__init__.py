"""glossmill.plans"""
