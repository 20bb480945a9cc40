"""Kit inventory reporting and reassembly as Spark DataFrame jobs."""

from rekit.sources.tables import InventoryCodes, Tables

__all__ = ["InventoryCodes", "Tables"]
