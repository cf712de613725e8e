"""Reading and writing star tables, flattening landed report files, table binding."""
