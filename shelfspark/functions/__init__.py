"""Column functions. All of them stay in the JVM unless their docstring says otherwise."""
