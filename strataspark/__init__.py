"""strataspark: grouped experimental measurements on Spark DataFrames.

Every public operator is a function ``DataFrame(s) + small declarations -> DataFrame``.
Units (rows of a study) are long tables ``(unit_id, feature, value)``; groups, sites,
classes, views and outcomes are ordinary columns.
"""
