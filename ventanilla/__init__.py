"""ventanilla: service-desk time analytics on Spark.

Reports of attention times (SOL) and card deliveries (CR) are cleaned,
deduplicated and gated into fact DataFrames; the operating questions
(counts, means, outliers, rankings, shares, latest report) are answered
with DataFrame / Spark SQL operators. Every operator takes and returns
DataFrames; nothing is collected to the driver.
"""

from ventanilla.session import get_session, checkpoint_dir  # noqa: F401
