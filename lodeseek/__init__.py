"""lodeseek: hybrid keyword and vector retrieval over source trees and corpora, on Spark."""

__version__ = "0.1.0"
