"""Fixed values of the domain."""

from __future__ import annotations

import math

# Named market periods, first and last day.
STRESS_PERIODS = [
    ("Dotcom", "2000-03-10", "2000-09-10"),
    ("Lehman", "2008-08-01", "2008-10-01"),
    ("9/11", "2001-09-11", "2001-10-11"),
    ("US downgrade/European Debt Crisis", "2011-08-05", "2011-09-05"),
    ("Fukushima", "2011-03-16", "2011-04-16"),
    ("US Housing", "2003-01-08", "2003-02-08"),
    ("EZB IR Event", "2012-09-10", "2012-10-10"),
    ("Aug07", "2007-08-01", "2007-09-01"),
    ("Mar08", "2008-03-01", "2008-04-01"),
    ("Sept08", "2008-09-01", "2008-10-01"),
    ("2009Q1", "2009-01-01", "2009-03-01"),
    ("2009Q2", "2009-03-01", "2009-06-01"),
    ("Flash Crash", "2010-05-05", "2010-05-10"),
    ("Apr14", "2014-04-01", "2014-05-01"),
    ("Oct14", "2014-10-01", "2014-11-01"),
    ("Fall2015", "2015-08-15", "2015-09-30"),
    ("Low Volatility Bull Market", "2005-01-01", "2007-08-01"),
    ("GFC Crash", "2007-08-01", "2009-04-01"),
    ("Recovery", "2009-04-01", "2013-01-01"),
    ("New Normal", "2013-01-01", "2025-12-31"),
]
# Sector codes.
SECTORS = {
    101: "Basic Materials",
    102: "Consumer Cyclical",
    103: "Financial Services",
    104: "Real Estate",
    205: "Consumer Defensive",
    206: "Healthcare",
    207: "Utilities",
    308: "Communication Services",
    309: "Energy",
    310: "Industrials",
    311: "Technology",
}
# Market capitalisation buckets, from and below.
CAP_BUCKETS = [("Micro", 5e7, 3e8), ("Small", 3e8, 2e9), ("Mid", 2e9, 1e10), ("Large", 1e10, 2e11), ("Mega", 2e11, math.inf)]
