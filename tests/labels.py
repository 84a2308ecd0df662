"""The normal form of a label, and other plain versions to test against."""

import re
import unicodedata


def normal(x):
    if x is None:
        return None
    x = unicodedata.normalize("NFKC", x).replace("​", "").replace("﻿", "").lower().strip(" \t\r\n\f\v")
    return re.sub(r"[ \t\r\n\f\v\-_]+", "_", x) or None


EDGE_SCHEMA = (
    "edge_id bigint, src_column string, edge_type_column string, dst_column string, edge_weight_column double, split string, source string, edge_ts timestamp_ntz, loaded_at timestamp_ntz"
)
