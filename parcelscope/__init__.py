"""parcelscope — last-mile delivery analytics as Spark jobs.

Every query is a function from DataFrames (held in a :class:`Model`) to a
lazy DataFrame.  Nothing is collected to the driver inside the library.
"""

from parcelscope.session import get_session, shared_dir
from parcelscope.sources.model import Model, materialize, model_for, read_model

__all__ = ["get_session", "shared_dir", "Model", "model_for", "materialize", "read_model"]
