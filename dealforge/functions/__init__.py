"""dealforge.functions"""
