"""Source text to relations: fixed-column and control languages in DataFrame operations, SQL by its tokens."""
