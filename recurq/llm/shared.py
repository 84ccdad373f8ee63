"""Tables in the shared folder, as the operators of this subpackage use them."""

from recurq.sources.shared import BROADCAST_ROWS, drop_path, maybe_broadcast, new_path, shared_dir, small, text_of, written, written_at

__all__ = ["BROADCAST_ROWS", "drop_path", "maybe_broadcast", "new_path", "shared_dir", "small", "text_of", "written", "written_at"]
