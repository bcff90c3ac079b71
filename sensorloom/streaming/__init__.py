"""The same operators on streams, and the few that need keyed state and timers."""
