"""gradeframe: Spark-native curation, grading and evaluation of graded
programming-submission logs.

Every operator is a plain function ``DataFrame -> DataFrame`` (or
``Column -> Column`` for scalar helpers in :mod:`gradeframe.functions`).
Operators never trigger actions and never hold a session of their own.
"""

__version__ = "0.1.0"
