"""Sources and sinks: manifests, snapshots and JSON documents."""
