"""Sources and sinks: text tables, JSON, images, pages over HTTP, and id ranges."""
