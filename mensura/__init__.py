"""mensura: DataFrame operators that turn text and tables of measurements into checked, comparable data."""

__version__ = "0.1.0"
