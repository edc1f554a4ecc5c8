"""DataFrame -> DataFrame operators over tables of many users, conversations and events."""
