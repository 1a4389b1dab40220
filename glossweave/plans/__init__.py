"""Plan building blocks that keep hot keys and long groups spread over tasks."""
