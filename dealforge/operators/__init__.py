"""dealforge.operators"""
