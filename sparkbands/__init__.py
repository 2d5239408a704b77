"""Spark operators for cohorts measured along ordered windows."""
