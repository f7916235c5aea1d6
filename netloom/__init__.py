"""netloom: netlist, graph and table analytics on PySpark DataFrames."""
