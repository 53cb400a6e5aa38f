"""Column functions: text, patterns and formatting, all evaluated in the JVM."""
