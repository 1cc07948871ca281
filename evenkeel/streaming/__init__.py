"""State kept over arriving rows."""

from evenkeel.streaming.state import class_counts_of, read_state, stream_update

__all__ = ["class_counts_of", "read_state", "stream_update"]
