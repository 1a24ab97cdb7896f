"""Affinity analytics on Spark.

Event logs -> user/item tables -> weighted affinities and popularity ->
implicit ALS factors and owned-cosmetic overlap -> a whole table of
requests answered at once (filter, score, top-N, blend).

Every public function takes and returns DataFrames; nothing on a data
path is collected to the driver.
"""

from affinity.config import Params
from affinity.session import build_session, checkpoint_dir

__all__ = ["Params", "build_session", "checkpoint_dir"]
