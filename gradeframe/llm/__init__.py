"""Operators of a training-data pipeline (WARC audit to sharding).

One module per operator; ``queries`` registers them.  Nothing outside this
package imports it.
"""
