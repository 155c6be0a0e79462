"""The same operators over streams, and the sinks that keep their results."""
