"""quarry: Spark-native operators for sort/shuffle, many-model training, trajectory
smoothing, majority voting and run-result analytics.

Every operator takes and returns DataFrames. Planning, shuffling and spilling are left
to Spark; Python runs only inside Arrow-batched functions where no built-in expression
exists (the streaming state machine).
"""

__all__ = ["session"]
