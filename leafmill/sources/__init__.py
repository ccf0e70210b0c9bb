"""Tables and views that the operators read."""
