"""Build, split, label and judge data sets of binding sequence pairs on Spark.

Every public function takes and returns ``DataFrame``s (or ``Column``s), so the
steps compose into one lazy plan.
"""

__version__ = "0.1.0"
