"""tokenflow: token-transfer analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (plus
parameters); nothing inside an operator collects data to the driver except
the few gates that must raise (completeness, strict enum check, duplicate
prediction addresses, empty label join).
"""

__version__ = "0.1.0"
