"""End-to-end plans: the report pipeline and the driver-table bindings."""
