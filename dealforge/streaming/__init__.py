"""dealforge.streaming"""
