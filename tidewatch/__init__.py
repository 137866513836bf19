"""Web-security event analytics as Spark DataFrame functions.

Every public function takes DataFrames (or Columns) plus explicit parameters and returns a lazy DataFrame (or
Column).  ``functions`` holds column expressions, ``operators`` holds DataFrame operators, ``sources`` holds
readers and writers, ``plans`` chains operators into whole jobs and ``streaming`` has the Structured Streaming forms.
"""
