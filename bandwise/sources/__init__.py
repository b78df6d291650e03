"""Reading tables, stacking them into one frame, writing scored results."""
