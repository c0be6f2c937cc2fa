"""From copybook text to record layouts."""
