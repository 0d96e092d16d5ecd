"""Spark jobs for underwater imaging stations: frames, tiles, detections, telemetry, catalogues."""
