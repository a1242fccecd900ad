"""DataFrame operators for curating labelled speech corpora and evaluating detectors on them."""

__version__ = "0.1.0"
