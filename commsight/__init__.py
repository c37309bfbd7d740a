"""commsight: country-level communications intelligence as Spark jobs.

Every public operator takes and returns DataFrames; nothing is collected to
the driver.  Sub-packages:

* ``sources``   - table scans, CSV/Parquet sinks, HTML and JSON payload parsing
* ``functions`` - column expressions (text cleaning, labels, formatting)
* ``operators`` - cleaning, ordered-sequence windows, entity selection,
                  joins, aggregates, ranking, report rendering, model calls
* ``plans``     - end-to-end report plans and driver-table bindings
* ``streaming`` - an optional Structured Streaming variant of the counts
"""

from commsight.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
