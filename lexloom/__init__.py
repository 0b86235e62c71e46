"""Document analytics on Spark: wiki-style markup, templates, page stores, histories, licences, layout and work queues."""
