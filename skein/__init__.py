"""skein: conversations, tool-call traces, documents and relational tables as Spark DataFrames."""
