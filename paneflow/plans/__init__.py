"""Composed queries.  Importing this package registers every query."""

from paneflow.plans import registry  # noqa: F401
from paneflow.plans import ysb  # noqa: F401
from paneflow.plans import lrb  # noqa: F401
from paneflow.plans import text  # noqa: F401
from paneflow.plans import nyt  # noqa: F401
from paneflow.plans import streams  # noqa: F401
from paneflow.plans import lrb_streams  # noqa: F401
from paneflow.plans import watermarks  # noqa: F401
from paneflow.plans import workloads  # noqa: F401
from paneflow.plans import operators  # noqa: F401
from paneflow.plans import sources  # noqa: F401
from paneflow.plans import stream_sources  # noqa: F401
from paneflow.plans import row_streams  # noqa: F401
from paneflow.plans import dags  # noqa: F401
