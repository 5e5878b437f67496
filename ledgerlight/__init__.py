"""ledgerlight: subscription-business analytics as distributed Spark jobs.

Every job is a pure function from DataFrames (plus an explicit reference
time ``as_of`` and parameters) to a DataFrame. Nothing is collected on the
driver except one-row statistics.
"""

from ledgerlight.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
