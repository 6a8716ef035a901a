"""dealforge.plans"""
