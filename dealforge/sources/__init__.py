"""dealforge.sources"""
