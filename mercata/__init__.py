"""mercata: marketplace order analytics as Spark DataFrame jobs.

Load the nine marketplace tables (``mercata.sources``), then call any report
in ``mercata.plans`` with a ``{table_name: DataFrame}`` mapping.  Reports are
lazy DataFrames; nothing is collected to the driver except bounded samples
for the distributed NTILE.
"""

__version__ = "0.1.0"
