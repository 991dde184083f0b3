"""weftmix: corpus mixing, example construction and model-evaluation tables on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` or ``-> Column`` function
built from Spark SQL expressions, so Catalyst plans, prunes and pushes down.
"""

from weftmix.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
