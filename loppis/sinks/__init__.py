"""Tables that are kept on disk and changed there."""
