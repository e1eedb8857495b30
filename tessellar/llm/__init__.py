"""Operators of a training-data pipeline: ten independent modules, each with its own general interface.

``queries`` registers one thin ``opN_<name>`` query per operator; nothing outside this package imports it.
"""
