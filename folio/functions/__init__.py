"""Column expressions: URLs, dates, text and Markdown. All of them run in the JVM."""
