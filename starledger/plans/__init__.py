"""Report plans: views and the A-H report catalogue."""
