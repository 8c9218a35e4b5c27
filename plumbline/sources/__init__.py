"""Sources and sinks: context bundles, policies, contracts, benchmark worlds, paginated services, reports."""
