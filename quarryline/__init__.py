"""Retrieval analytics and corpus preparation as PySpark DataFrame operators."""

import os

# Spark runs a task on each core: threads inside numpy would only compete with them.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")
