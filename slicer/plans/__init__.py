"""Plan-time objects: schema model, configuration, graph and anchors; all sized by the schema, not by data."""
