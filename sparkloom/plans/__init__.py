"""Named queries and what their plans look like."""
