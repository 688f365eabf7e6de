"""opsight: Spark-native monitoring operators over load-framework metadata.

Every operator is a pure ``DataFrame(s) -> DataFrame`` function built from
built-in Spark expressions, with an explicit ``as_of`` clock where the
questions are relative to "now".  See README.md for the operator list.
"""

from opsight.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
