"""cartlake: Spark-native operators for retail-assistant data.

Every operator is a function DataFrame(s) -> DataFrame that builds a lazy
logical plan; nothing is collected to the driver inside an operator.
"""

__version__ = "0.1.0"
