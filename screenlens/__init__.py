"""screenlens: screen-change and dialogue analytics over corpora of recorded lectures, on Spark."""

__version__ = "0.1.0"
