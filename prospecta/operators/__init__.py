"""DataFrame -> DataFrame operators over the campaign tables and logs."""
