"""The change feed: batch functions and the streams that reuse them."""
