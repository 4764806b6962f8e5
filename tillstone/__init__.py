"""Retail customer analytics on Spark: reports, RFM scoring and segmentation."""

from tillstone.plans.mart import Mart, open_mart

__all__ = ["Mart", "open_mart"]
