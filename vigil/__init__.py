"""Safety-event analytics and data-quality operators for PySpark."""
