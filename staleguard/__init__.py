"""staleguard: Spark-native document-conflict and RAG data-quality toolkit.

Everything is expressed with the DataFrame / SQL API so Catalyst plans the
joins, shuffles and pushdowns; see README.md for the module map.
"""

from staleguard.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
