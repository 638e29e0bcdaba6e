"""The operators; ``rollcall`` exports them."""
