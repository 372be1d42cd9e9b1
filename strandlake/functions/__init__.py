"""Native column expressions over sequences."""
