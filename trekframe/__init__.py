"""trekframe: route, planning and corpus analytics written as PySpark DataFrame operators."""
